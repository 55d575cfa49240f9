"""Jobs over large collections of cardiac electroanatomical maps, on Spark."""

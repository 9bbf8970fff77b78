"""tabsonde: table profiling, cleaning and statistics as Spark jobs."""

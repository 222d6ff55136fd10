"""Urban analytics on Spark: DataFrame operators over networks, agents, grids and feeds."""

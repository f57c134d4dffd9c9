"""kelpie: composable DataFrame operators for capture-data auditing and preparation on Spark."""

"""linkloom: click-graph similarity and relational batch operators on Spark."""

"""Style coverage analytics on Spark: markup, stylesheets and component graphs as DataFrames."""

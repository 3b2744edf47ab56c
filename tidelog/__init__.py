"""tidelog: a partitioned message-log engine expressed as Spark DataFrame plans."""

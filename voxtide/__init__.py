"""A Spark-native engine that turns streams of short feedback messages into tracked incidents."""

"""A Spark-native analytics engine for streams of short documents."""

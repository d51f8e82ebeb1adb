"""quillgraph: a Spark-native analytics engine for code graphs."""

"""sparkloom: Spark-native analytics over software history, structure and text."""

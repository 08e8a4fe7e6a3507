"""postgrain: a Spark-native analytics engine for messy posting, organisation and form data."""

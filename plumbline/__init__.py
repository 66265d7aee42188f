"""Spark-native analytics for question/answer text, captions and the vectors beside them."""

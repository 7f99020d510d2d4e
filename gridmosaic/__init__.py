"""gridmosaic: Spark-native operators for question answering data over tables
whose cells mix text and image placeholders."""

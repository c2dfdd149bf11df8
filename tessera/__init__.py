"""Analytics on sparse detector-style images and on text corpora, as Spark DataFrame operators."""

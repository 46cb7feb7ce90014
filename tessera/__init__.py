"""Tessera: corpus preparation, question-answer evaluation and the statistics on top of them, as Spark DataFrame operators."""

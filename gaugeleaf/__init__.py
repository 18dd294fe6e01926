"""Analytics over question-answering output, as Spark DataFrames."""

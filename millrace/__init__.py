"""Analytics over conversation corpora, evaluation results and review evidence, as Spark DataFrames."""

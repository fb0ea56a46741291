"""siftmill: text-corpus, retrieval and question-answer data jobs as Spark DataFrames."""

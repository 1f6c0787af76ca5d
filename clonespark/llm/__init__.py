"""Training-data operators: LM scoring, archives, classifiers, deduplication, mixing, search, tokenisation.

Every operator takes and returns DataFrames; ``registry`` lists the queries made of them.
"""

"""Operators that prepare isolation texts and embeddings as training data.

Nothing outside this folder imports it. Every operator is a Spark job; numpy
works inside the tasks on blocks of a few megabytes of text.
"""

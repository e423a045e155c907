"""Phoneme analytics on Spark: kernels, rules, metrics and model selection over tables of utterances."""

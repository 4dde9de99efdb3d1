"""Distillation data and evaluation jobs on Spark.

``functions``  Column-to-Column expressions (answers, prompts, retries, metrics)
``operators``  DataFrame-to-DataFrame steps (grading, attempt log, chat, sampling)
``sources``    scans and sinks (problem sets, completions, stats text, keyed results)
``plans``      the three jobs end to end: generate, training text, evaluate
``streaming``  the same aggregates while rows still arrive
"""

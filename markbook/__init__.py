"""Marking and ranking of exam answers as Spark DataFrame jobs.

``functions``  Column -> Column expressions (text, extraction, prompts, scores)
``operators``  DataFrame -> DataFrame steps (routing, few-shot, inference, reports)
``sources``    readers and writers (question bank, dimensions, results, ledger)
``plans``      physical helpers (sized joins, running totals) and whole evaluations
``catalog``    the registered queries over the driver's tables, with their SQL
"""

"""Training-data operators: quality, decontamination, PII, chat, toxicity, mixing, language, LM, near and substring duplicates.

Nothing else in the library imports this subpackage.
"""

"""Training-data operators: near-duplicates, HTML extraction, quality rules, language-model
scores, WARC archives, decontamination, URL filters, BPE, licence scans, language ID.

Nothing else in the library imports this subpackage. Each operator module has its own general
interface; ``queries`` holds the thin registered queries over the given tables.
"""

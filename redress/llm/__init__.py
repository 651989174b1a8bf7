"""Training-data operators: archives, near duplicates, filters, classifiers,
secret scans, tokenisation and packing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""

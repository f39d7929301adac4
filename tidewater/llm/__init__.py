"""Training-data operators: near-duplicates, neighbours, quality, decontamination, URLs, shards, packing, ids, HTML, PII,
lexical search, tokenizer alignment, n-gram joins."""

"""Training-data operators: token counts, quality, LM scores, chat, URLs, packing, near-dups, search, leaks, language."""

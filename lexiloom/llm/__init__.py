"""Training-data operators: packing, token files, BPE, toxicity, near-duplicates, fixity, quality, media, chat.

Nothing else in ``lexiloom`` imports this subpackage; it can be removed as a whole.
"""

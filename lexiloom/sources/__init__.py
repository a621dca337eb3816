"""Readers and writers: annotated sentences, examples, models, manifests."""

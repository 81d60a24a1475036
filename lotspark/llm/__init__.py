"""Training-data operators (deduplication, decontamination, PII, tokens, ...).

Nothing outside this folder imports it; ``queries`` registers what the
repository's entry point exposes.
"""

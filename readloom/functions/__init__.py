from readloom.functions import dna, stats

__all__ = ["dna", "stats"]

"""Media organising, near-duplicate detection and text preparation as Spark plans."""

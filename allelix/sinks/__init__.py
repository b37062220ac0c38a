"""Writers, as text or tables."""

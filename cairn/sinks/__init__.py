"""Writers with the write semantics the result tables need."""

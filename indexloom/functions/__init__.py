"""Column functions: fixed-point arithmetic, flags, routing, binary frames and exchange messages."""

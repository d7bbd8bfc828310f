"""Frame streams: state that is carried over micro-batches."""

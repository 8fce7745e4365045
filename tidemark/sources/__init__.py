"""Table scans, decoders and adapters onto the engine's schemas."""

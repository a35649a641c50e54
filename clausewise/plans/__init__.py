"""Question answering as DataFrame programs."""

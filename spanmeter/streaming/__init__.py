"""The log operators and the detectors over inputs which keep arriving."""

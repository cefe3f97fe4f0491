"""Engine parts: containers, extraction and pipelines."""

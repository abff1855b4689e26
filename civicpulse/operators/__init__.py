"""Frame-level operators: ``DataFrame -> DataFrame``, no actions unless stated."""

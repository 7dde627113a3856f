"""Running calibration on streams."""

"""Decoders and encoders of sensor data, for use inside Arrow batches."""

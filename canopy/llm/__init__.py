"""Training-data operators: dedup, joins, filters, models, encoders, converters."""

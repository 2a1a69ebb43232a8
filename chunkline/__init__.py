"""chunkline: preparation and evaluation of chunked, annotated sequence datasets on Spark."""

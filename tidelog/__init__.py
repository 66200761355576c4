"""tidelog: versioned, deduplicated file catalogues as DataFrames."""

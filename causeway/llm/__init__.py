"""Operations of a training-data pipeline: language, quality, duplicates, mixing, packing, search."""

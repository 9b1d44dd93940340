"""Training-data operators: language id, packing, quality, token files, near and exact duplicates,
decontamination, n-gram scoring, chat rendering and token counts."""

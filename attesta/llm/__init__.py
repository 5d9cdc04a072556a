"""Training-data operators: length statistics, near-duplicates, mixing, language,
decontamination, licences, web archives, quality and embedding de-duplication."""

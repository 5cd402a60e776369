"""Operators of a training-data pipeline: extraction, language and quality scores, search,
decontamination, secret and license scans, exact and near de-duplication, and mixing."""

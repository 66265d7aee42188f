"""Operations of a training-data pipeline: cleaning, decontamination, sharding, de-duplication,
chat formatting, packing, token counts, binary output, language identification, clustering,
importance resampling and repeated byte strings.

Nothing outside this subpackage imports it.
"""

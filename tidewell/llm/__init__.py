"""Operations of a training-data pipeline over text tables.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and column names, looks only at the columns it needs (others are left out or pass
through, whatever their names), and treats a null text as the empty text.
"""

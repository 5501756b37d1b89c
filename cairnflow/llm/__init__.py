"""Operations for large-scale training-data preparation.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns DataFrames; the thin queries over the test tables are in
:mod:`cairnflow.llm.queries`.
"""

"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Nothing else in the package imports this folder. ``queries`` registers one
query ``opN_<name>`` per operator; ``corpus_pipeline.py`` at the repository top
chains five of them.

Common conventions: operators select the columns they need by name, so extra
columns never clash; a null text counts as the empty text unless said
otherwise; a null id is carried through row-wise operators and never matches
another row. Python work runs in Arrow batches that are cut to a few MB of
text, so a task's memory does not depend on the batch size Spark chose.
"""

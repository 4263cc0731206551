"""Operations for large-scale training-data pipelines.

Ten self-contained operators; nothing else in the library imports this
subpackage.  ``registry`` lists the driver-facing queries.
"""

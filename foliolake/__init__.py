"""foliolake: a PySpark-native document analytics engine.

Documents (PDF bytes, HTML pages, plain text) are read into relations with
explicit ordinals; every operator is a DataFrame transformation.
"""

__version__ = "0.1.0"

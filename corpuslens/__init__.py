"""corpuslens: Spark-native curation and analytics for collections of short labelled texts."""

__version__ = "0.1.0"

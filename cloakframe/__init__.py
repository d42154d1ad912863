"""cloakframe: finding and redacting sensitive data in text with Spark DataFrames."""

__version__ = "0.1.0"

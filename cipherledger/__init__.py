"""cipherledger: cryptographic-inventory analytics as Spark DataFrame stages."""

__version__ = "0.1.0"

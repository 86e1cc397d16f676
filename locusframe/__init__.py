"""locusframe: lazy DataFrame operators for annotation tables, interval sets, signal tracks and text corpora on Spark."""

__version__ = "0.1.0"

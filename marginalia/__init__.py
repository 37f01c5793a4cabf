"""Transcription-corpus analytics on PySpark DataFrames."""

"""Transcript and speech-corpus analytics expressed as Spark DataFrame operators."""

"""Spark-native rescoring and analytics of peptide spectrum matches."""

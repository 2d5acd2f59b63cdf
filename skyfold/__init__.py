"""Aerial survey analytics as composable Spark DataFrame operators."""

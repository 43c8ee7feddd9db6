"""Composable DataFrame -> DataFrame operators."""

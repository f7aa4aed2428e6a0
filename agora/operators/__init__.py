"""Reusable DataFrame operators (plain functions DataFrame -> DataFrame)."""

"""Operators: functions from DataFrame to DataFrame, for batch tables unless noted."""

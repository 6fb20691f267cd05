"""Inputs: the billing export adapter and the driver-table fixtures."""

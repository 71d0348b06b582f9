"""Preparation, samplers, protocol, registered queries."""

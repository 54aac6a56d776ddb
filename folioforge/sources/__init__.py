"""Readers of binary documents."""

"""Queries: importing this subpackage registers them all."""

"""Terrain, route and corpus analytics on Spark."""

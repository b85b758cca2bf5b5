"""marlspike: corpus preparation and evaluation analytics as lazy Spark plans."""

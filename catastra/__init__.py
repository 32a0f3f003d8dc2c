"""Catastra: property-listing and due-diligence analytics as Spark DataFrame jobs."""

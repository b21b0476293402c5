"""webloom: site-quality findings and a growing link index as Spark jobs."""

__version__ = "0.1.0"

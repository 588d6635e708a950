"""Change-event analytics on Spark: operators over keyed, ordered change logs."""

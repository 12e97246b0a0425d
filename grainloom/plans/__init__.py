"""Feature tables, news scores, classifiers, forecast bands, decisions."""

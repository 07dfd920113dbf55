"""Spark-native curation of crawled web pages: extraction, url and image
rules, de-duplication, crawl planning, operational statistics and alerts."""

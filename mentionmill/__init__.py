"""News-text analytics on Spark: extract, link, enrich, score and count entity mentions."""

"""Page-layout, image-evaluation and mask-dataset analytics as Spark DataFrame operators."""
